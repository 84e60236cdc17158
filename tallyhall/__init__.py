"""tallyhall: PySpark-native analytics of open collaboration.

The library is made of lazy ``DataFrame -> DataFrame`` operators and
``Column -> Column`` functions; nothing is computed until an action.
"""

__version__ = "0.1.0"
