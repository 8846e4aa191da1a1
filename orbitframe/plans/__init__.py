"""Settings, naming and end-to-end plans."""
