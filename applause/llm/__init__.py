"""Operations of a training-data pipeline on ``documents``, ``pages`` and ``benchmark`` shaped tables.

Nothing outside this subpackage imports it. Its functions travel to the executors by value, so a cluster needs
only the third-party libraries, not this package, on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
