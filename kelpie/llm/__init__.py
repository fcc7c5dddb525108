"""Training-data operators.  Nothing else in the library imports this subpackage."""

import os
from pathlib import Path

import kelpie
from pyspark import cloudpickle

# Workers that cannot import this package get its functions by value.
if str(Path(__file__).resolve().parents[2]) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(kelpie)
