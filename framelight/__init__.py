"""Packet-capture analytics on Spark: capture sources, dissection, connection tracking, field lookup."""
