"""trimlake: corpus slimming and analysis on Spark."""
