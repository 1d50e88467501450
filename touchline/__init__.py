"""Match analytics for recorded team-sport games, written as Spark DataFrame operators."""
