"""orrery: a Spark-native engine for star-schema warehouses.

Operators are pure ``DataFrame -> DataFrame`` functions (``orrery.operators``);
storage, planning and streaming are thin shells around them.
"""

__version__ = "0.1.0"
