"""Reading bars, building bars from trades, and writing results."""
