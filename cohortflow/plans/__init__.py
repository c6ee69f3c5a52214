"""End-to-end plans: feature preparation, forecasting sweep, effect study."""
