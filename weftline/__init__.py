"""weftline: a column-oriented analytics engine on Spark DataFrames.

Definitions are attached to tables and columns; the planner compiles them to
lazy DataFrame plans.  The data-quality operators in ``weftline.operators``
work directly on DataFrames.
"""

__version__ = "0.1.0"
