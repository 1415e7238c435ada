"""Thresholds and parameters of the raster engine, in one place."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# They must be these for results to agree with the established processing.
TARGET_EPSG = 3857
COREG_BAND = 1
MAX_SHIFT_PIXELS = 30
TARGET_SIZE = 4096
BASE_SIZE = 1024
CLOUD_BRIGHTNESS = 200
SHADOW_DARK = 40
SHADOW_BLUE_RATIO = 1.1
VEGETATION_INDEX = 0.10
MIN_USABLE_PIXELS = 10_000
MIN_ZSCORE_VALUES = 10
MIN_LAB_VALUES = 100
PIF_LOW, PIF_HIGH = 60, 190
PIF_PERCENTILE = 0.30
MIN_PIF_PIXELS = 500
STD_EPSILON = 1e-8
PATCH_SIZE = 256
GRID = 16
NODATA_SHARE = 0.90
BACKGROUND_KEEP = 0.10
SPECTRAL_THRESHOLD = 15.0
LABEL_SCALE = 4
SAMPLE_SEED = 42
PIPELINE_VERSION = "1.0"
BOUNDARY_PX = 2
CONTACT_PX = 3
PEAK_DISTANCE = 3
WINDOW_MONTHS = 5
MIN_MONTH_GAP = 12
EPOCH_SAMPLES = 25_000
CHANGED_SHARE = 0.7
CHANNEL_MEAN = (0.4736, 0.4196, 0.3154)
CHANNEL_STD = (0.2381, 0.1894, 0.1756)
SPLIT = (0.70, 0.15, 0.15)
POS_WEIGHTS = (4.1, 10.0, 10.0)
CHANNEL_WEIGHTS = (1.0, 3.0, 3.0)
CHANGE_POS_WEIGHT = 7.0
AUX_WEIGHT = 0.4
TRAIN_THRESHOLD, SEG_THRESHOLD, CHANGE_THRESHOLD = 0.5, 0.45, 0.35
SWEEP = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65)
BANDS = ("r", "g", "b")

# Linear sRGB to XYZ (D65, 2 degrees), its white point, and the CIELab split.
RGB_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)
LAB_SPLIT, LAB_SLOPE, LAB_SHIFT = 0.008856, 7.787, 16.0 / 116.0


@dataclass(frozen=True)
class TrainConfig:
    """Settings of a training run; ``base`` is the width of the first network stage."""

    n_months: int = WINDOW_MONTHS
    fbc_channels: int = 1
    base: int = 32
    batch_size: int = 8
    epochs: int = 100
    warmup_epochs: int = 5
    learning_rate: float = 1e-4
    weight_decay: float = 1e-3
    gradient_clip: float = 0.5
    change_pos_weight: float = CHANGE_POS_WEIGHT
    threshold: float = TRAIN_THRESHOLD
    cities: tuple[str, ...] = field(default_factory=tuple)

    def model_settings(self) -> dict:
        return {"in_channels": 3, "n_months": self.n_months, "fbc_channels": self.fbc_channels, "base": self.base}

    def as_dict(self) -> dict:
        return asdict(self)
