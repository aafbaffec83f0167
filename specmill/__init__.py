"""specmill: specification extraction as Spark jobs.

Documents -> pages -> excerpt -> model reply -> validated record -> upserted
record table and processed-file ledger -> filtered, paged and summarised views.
Every operator is a function from DataFrame (or Column) to DataFrame (or Column).
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their job, so executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
