"""Training-data operators: jobs over documents, pages, embeddings and conversations.

Nothing outside this subpackage imports it. Each module holds one operator with a general DataFrame
interface; ``queries`` registers the thin digest queries.
"""

import sys

from pyspark import cloudpickle

#: Functions travel to the executors by value, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
