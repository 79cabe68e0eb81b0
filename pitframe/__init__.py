"""pitframe: point-in-time time-series research as PySpark DataFrame plans."""
