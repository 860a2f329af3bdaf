"""arborlens: biodiversity and habitat analytics as Spark DataFrame transformations.

Task functions of this package are pickled by value, so executors need no copy of it on their Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
