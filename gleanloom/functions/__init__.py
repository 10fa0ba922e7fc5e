"""Column expressions and the few Arrow kernels behind them."""
