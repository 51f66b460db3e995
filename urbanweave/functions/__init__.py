"""Column functions: casts, calendar, fares, cells and display values."""
