"""Sources and sinks: versioned tables, the landing area, seeds and sheets."""
