"""folioscope: literature analytics expressed as Spark plans.

Every operator is a function from DataFrames to a DataFrame; nothing here holds
a session of its own.
"""

__version__ = "0.1.0"
