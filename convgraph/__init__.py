"""convgraph: conversation-graph and multi-label corpus analytics on Spark.

Every public operator is a pure ``DataFrame -> DataFrame`` or
``Column -> Column`` function.  Nothing is collected to the driver except
scalar loop counters inside the iterative graph jobs.
"""

__version__ = "0.1.0"
