"""Options and volatility analytics on PySpark."""
