"""Made-up structures for tests."""

import numpy as np


def pocket_cloud(seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Points of a made-up structure with a hidden pocket: core 0-19, channel 20-31, pocket 32-45, surface 46-65; and labels."""
    g = np.random.default_rng(seed)
    centre = np.concatenate([np.zeros((20, 3)), np.linspace([4, 0, 0], [12, 0, 0], 12), np.tile([15.0, 0, 0], (14, 1)), g.normal(0, 1, (20, 3)) * 9])
    return centre + g.normal(0, 2.0, (66, 3)), ((np.arange(66) >= 32) & (np.arange(66) < 46)).astype(int)
