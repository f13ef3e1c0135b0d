"""Stands for h5py where it is missing: files are dictionaries of arrays."""

import numpy as np

FILES: dict = {}


class File(dict):
    def __init__(self, path, mode):
        super().__init__(FILES.get(path, {}))
        self.path = path

    def create_dataset(self, name, data):
        self[name] = np.array(data)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        FILES[self.path] = dict(self)
