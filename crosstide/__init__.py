"""crosstide: DataFrame operators for (entity, date) panels on Spark."""
