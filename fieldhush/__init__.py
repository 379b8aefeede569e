"""Event-anchored analysis of sensor clip tables as plain DataFrame -> DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python workers need not have the package installed: its functions travel with the job.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
