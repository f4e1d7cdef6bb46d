"""Operators for preparing language-model training text. Nothing outside this
package imports it.

Its functions travel to the executors by value, so that a cluster runs them
without the package being installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
