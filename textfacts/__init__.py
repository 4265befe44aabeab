"""Text-corpus preparation and summary-faithfulness scoring on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python helpers run inside Arrow functions; ship them with the job so
# that executors need no copy of this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
