"""Training-data operators.

Nothing else in the library imports this subpackage, and it imports nothing
from the rest.  Functions of this subpackage that run on executors are pickled
by value, so executors need numpy, pyarrow and the named third-party libraries
but not this package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
