"""ledgerloom - profile, clean, conform, master and model messy business tables on Spark."""
