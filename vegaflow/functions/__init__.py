"""Column-valued functions: rounding, normal distribution, Black-Scholes terms, calendars."""
