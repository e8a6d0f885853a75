"""Operators that prepare text corpora for training.

The modules here are self-contained: nothing else in the library imports them.
Functions that run on executors are pickled by value, so executors need only
the public libraries and not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
