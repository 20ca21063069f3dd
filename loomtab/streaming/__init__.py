"""The stages as Structured Streaming jobs; each ends with the data there is (``availableNow``) or runs on."""
