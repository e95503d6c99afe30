"""PySpark-native analytics for positioning and phone-sensor event logs."""
