"""Training-data operators: ten corpus components on Spark DataFrames.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own interface; ``queries`` wires them to the driver's tables.
"""
