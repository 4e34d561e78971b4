"""Column expressions shared by the operators (all built-in, JVM-side)."""

from packetloom.functions.net import (  # noqa: F401
    cidr_bounds,
    decode_payload,
    host_of,
    ip_number,
    is_ipv4,
    parent_domain,
)
from packetloom.functions.score import display_colour, severity, traffic_tier  # noqa: F401
from packetloom.functions.timing import epoch_us, from_epoch_us, slot_of, utc_text  # noqa: F401
