"""tallycard: screening rules and integer score cards on Spark DataFrames."""
