"""Cost, utilisation and reliability analytics for a data platform, on PySpark.

Operators are functions from DataFrames (plus a ``Clock`` and a ``Config``) to a
DataFrame. None of them reads the wall clock or collects an entity list to loop
over it on the driver.
"""

from meterwise.clock import Clock
from meterwise.config import Config

__all__ = ["Clock", "Config"]
