"""Training-data operators: token counts, sharding, sanitising, near copies, packing,
nearest neighbours, decontamination, archive fixity, secrets and language.

Nothing outside this folder imports it.  Worker functions are pickled by value, so
executors need not have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
