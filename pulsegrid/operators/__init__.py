"""DataFrame operators: images and videos, signals, masks, morphology, velocity, inference."""
