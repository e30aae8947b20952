"""Fixed names and numbers of the domain."""

from __future__ import annotations

EPOCH_SECONDS = 30
PSD_SECONDS = 6

#: Sleep stages and their codes; unknown is -1.
STAGES = {0: "Wake", 1: "N1", 2: "N2", 3: "N3", 4: "REM"}
UNKNOWN_STAGE = -1

#: Frequency bands in Hz, ends included.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}
PAIR_BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "sigma": (12.0, 16.0), "beta": (16.0, 30.0), "gamma": (30.0, 40.0)}

#: Event classes of the detector, in the order of its outputs.
EVENT_CLASSES = ["SS", "KC", "SW", "SAW", "VSW", "BG", "AR"]
EVENT_WINDOW = 300

MAX_LAG = 30
QC = {"feature_missing": 0.50, "row_missing": 0.30, "iqr_factor": 3.0, "min_variance": 1e-8}
IQR_TO_SD = 1.3489795003921634
