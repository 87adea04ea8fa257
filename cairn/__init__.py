"""Analytics over software history and knowledge graphs, as Spark plans."""
