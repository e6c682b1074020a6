"""routelens: offline evaluation of model routers as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions; Python runs inside tasks only where numpy is the natural tool
(block nearest-neighbour products, gradient sums of the learned routers).
"""

__version__ = "0.1.0"
