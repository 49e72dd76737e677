"""colsieve: rank, select and evaluate the columns of labelled tables with Spark plans."""
