"""Parameter values. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

# Class taxonomy, alphabetical; the position is the class id.
TAXONOMY = (
    "Aircraft",
    "Alarm",
    "Baby_Crying",
    "Car_Engine",
    "Dog_Bark",
    "Doorbell",
    "Drilling",
    "Footsteps",
    "Glass_Breaking",
    "Gunshot",
    "Help_Shouting",
    "Jackhammer",
    "Knocking",
    "Motorcycle",
    "Siren",
    "Train",
    "Vehicle_Horn",
)

# Audio modes.
AUDIO_MODES = (
    "Maximum ANC Mode",
    "Transparency Mode",
    "Safety Transparency Mode",
    "Low-Power Standby Mode",
)

# Window presets (window samples, step samples, FFT size, hop, mel bands) at 16 kHz.
PRESETS = {
    "A": (3200, 1600, 1024, 512, 64),
    "B": (16000, 8000, 1024, 512, 64),
    "C": (3200, 3200, 512, 128, 64),
    "D": (8000, 4000, 1024, 512, 64),
    "E": (32000, 16000, 1024, 512, 64),
}

SAMPLE_RATE = 16000
TRUNCATE_SECONDS = 15.0
MIN_SECONDS = 0.5
SILENT_DBFS = -60.0

# Split shares, seed and gate thresholds (flag, severe).
SPLITS = ("train", "val", "test")
RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}
SPLIT_SEED = 42
PROPORTION_TOLERANCE = 0.05
KS_MIN_N = 15
KS_THRESHOLDS = {
    "duration": (0.20, 0.40),
    "rms_db": (0.15, 0.30),
    "feature_mean": (0.15, 0.30),
}
MEAN_DELTA = (0.03, 0.08)
SILENCE_SPREAD = (0.02, 0.05)
FLOOR_FRACTION = (0.05, 0.20)
CEILING_FRACTION = (0.01, 0.05)
PAD_FRACTION = (0.0, 0.10)

# File-health thresholds.
HEALTH = {
    "extreme_short": 0.5,
    "short": 1.0,
    "long": 15.0,
    "very_long": 30.0,
    "silent_db": -60.0,
    "low_energy_db": -45.0,
    "clip_peak": 0.999,
    "clip_fraction": 0.001,
}

# Trigger policy defaults.
POLICY_DEFAULTS = {
    "enabled": False,
    "target_mode": None,
    "confidence_threshold": 0.80,
    "confirm_windows": 3,
    "release_seconds": 5.0,
    "cooldown_seconds": 5.0,
    "high_priority": False,
    "critical": False,
    "quick_action_label": None,
    "notify": True,
}

# Earbud response of each class.
EARBUD_RESPONSES = {
    "Aircraft": "Max ANC Mode",
    "Alarm": "Alert Mode",
    "Baby_Crying": "Transparency Mode",
    "Car_Engine": "Max ANC Mode",
    "Dog_Bark": "Transparency Mode",
    "Doorbell": "Alert Mode",
    "Drilling": "Max ANC Mode",
    "Footsteps": "Max ANC Mode",
    "Glass_Breaking": "Safety Transparency Mode",
    "Gunshot": "Safety Transparency Mode",
    "Help_Shouting": "Safety Transparency Mode",
    "Jackhammer": "Max ANC Mode",
    "Knocking": "Transparency Mode",
    "Motorcycle": "Max ANC Mode",
    "Siren": "Alert Mode",
    "Train": "Max ANC Mode",
    "Vehicle_Horn": "Alert Mode",
}

# What a user's answer to a quick action is told and logs.
USER_ACTIONS = ("confirm", "reject")
ACTION_NOTES = {
    "confirm": "presentation-only UI shortcut prototype; no action was executed and no emergency capability is claimed",
    "reject": "dismissed; no action was executed",
}
ACTION_LOGS = {
    "confirm": "quick action confirmed by user for '%s': %s (presentation-only; the supervisor executed nothing)",
    "reject": "quick action dismissed by user for '%s': %s",
}
UNKNOWN_ACTION = "action must be 'confirm' or 'reject'"
NONE_PENDING = "no user-confirmed quick action is currently pending"
