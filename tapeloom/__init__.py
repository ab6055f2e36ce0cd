"""Market time-series analytics on Spark: tape, bars, structure, setups, simulation, research."""
