"""Schemas of the engine's tables."""

from __future__ import annotations

FRAMES = (
    "file string, format string, number int, block_type bigint, interface_id bigint, link_type int, ts_hi bigint, ts_lo bigint, cap_len bigint, "
    "orig_len bigint, raw binary, status string"
)
#: What the readers add, as they meet a file's frames in order: the anchors of pcapng times as they hold at a frame, a DNS message's records, and
#: the section and the place among the file's blocks (pcapng).
PARSED = FRAMES + ", zero_sec bigint, zero_us bigint, dns string, section int, block_ordinal int"
BLOCKS = "file string, block_ordinal int, block_type bigint, total_length bigint, status string"
#: ts_resol and ts_offset as the options give them (6 and 0 without): decimal digits of a timestamp's unit, or from 128 on binary ones, and seconds.
INTERFACES = (
    "file string, section int, interface_id bigint, block_ordinal int, link_type int, reserved int, snap_len bigint, ts_resol int, ts_offset bigint, "
    "name string, description string, status string"
)
STATISTICS = "file string, block_ordinal int, interface_id bigint, ts_hi bigint, ts_lo bigint, status string"
NAMES = "file string, section int, block_ordinal int, record_type int, address string, names array<string>"

#: Fixed value: the type of an enhanced packet block.
ENHANCED = 6
#: EtherTypes, IP protocols, ports.
IPV4, IPV6, ARP, RARP = 0x0800, 0x86DD, 0x0806, 0x8035
ICMP, TCP, UDP, ICMPV6 = 1, 6, 17, 58
TELNET, SMTP, BGP = 23, 25, 179
DNS, DHCP, SNMP = (53,), (67, 68), (161, 162)
#: Flag masks in the order in which they are shown.
TCP_FLAGS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32}
