"""Operations of a large training-data pipeline; nothing outside this folder imports it."""

from pyspark import cloudpickle

import strataloom.llm as _own

# Workers get this subpackage's functions by value, so that executors need no copy of the repository.
cloudpickle.register_pickle_by_value(_own)
