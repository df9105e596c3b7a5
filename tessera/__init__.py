"""Tessera: a PySpark-native analytics engine (see README.md)."""

import os

# Small dense solves gain nothing from BLAS threads, which may starve each other beside a local JVM.
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
