"""Operators for preparing training data.  Nothing outside this subpackage imports it."""

from pyspark import cloudpickle

import spanveil

# Python functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(spanveil)
