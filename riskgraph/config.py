"""Thresholds and tables of the risk domain; immutable."""

from __future__ import annotations

# They must equal the reference's for right results.
CASH_SINK = -1
CASH_CHANNELS = ("ATM", "AEPS")
CHANNEL_GROUPS = {"upi": ("UPI",), "imps": ("IMPS",), "neft_rtgs": ("NEFT", "RTGS"), "atm_aeps": ("ATM", "AEPS"), "card": ("CARD", "WALLET")}
STRUCTURING_BAND = (45_000, 50_000)
SUB_THRESHOLD_BAND = (20_000, 100_000)
FRESH_HOURS = 24
FRESH_PAYEE_HOURS, REPORT_ABOVE = 1.0, 100_000
FLOW_SECONDS, FLOW_HOPS, FLOW_FAN_OUT, FLOW_PATHS = 48 * 3600, 4, 3, 25
ACTIVE_SHARE, SMALL = 0.01, 1e-9
STR_FILING_DAYS = 7
RAPID_SECONDS, BURST_SECONDS, VELOCITY_SECONDS = 3600, 1800, 3600
NIGHT_HOURS = (0, 5)
MAX_SHARED = 25
EDGE_WEIGHTS = {"DEVICE": 6.0, "IP": 1.5}
DAMPING = 0.85
BANDS = ((85, "CRITICAL"), (65, "HIGH"), (40, "MEDIUM"), (0, "LOW"))
RULE_WEIGHTS = {"R01": 3.0, "R02": 2.0, "R03": 3.0, "R04": 2.5, "R05": 2.0, "R06": 1.5, "R07": 2.0, "R08": 1.5}
PRIOR_BLEND = {"xgb": 0.45, "graph": 0.25, "temporal": 0.20, "intel": 0.10}
CTR_THRESHOLD = 1_000_000
KILLSWITCH_FLOOR, MIN_LAYERS, LAYER_THRESHOLD, FREEZES_PER_HOUR = 85, 2, 0.5, 25
LISTED_FLOOR, NEIGHBOUR_BONUS = 75.0, 8.0
NO_TICKET_RECENCY = 999.0
LAST_EVENTS = 64
