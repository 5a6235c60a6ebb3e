"""A PySpark-native analytics engine for clinical waveform, event and cohort data."""
