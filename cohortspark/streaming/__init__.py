"""Streaming use of the stateless operators.

The original tool has no streaming part; the flagging operators (regex flags,
phrase flags without roll-up, preprocessing projections) are per-row
projections and therefore accept a streaming DataFrame unchanged.  Roll-ups and
metrics are batch aggregates over a finished split and are not offered on
streams (no watermark or state is added).
"""
