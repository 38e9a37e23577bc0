"""Operators of a training-data pipeline. Nothing else in the library imports them."""

from pyspark import cloudpickle

import shelfmark

# Mappers travel inside the task, so executors need no install.
cloudpickle.register_pickle_by_value(shelfmark)
