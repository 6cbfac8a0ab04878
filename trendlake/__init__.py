"""trendlake: DataFrame-to-DataFrame operators for how item features change over time."""
