"""Linear-time plans for trailing-window computations over skewed accounts."""
