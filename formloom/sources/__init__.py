"""Evidence sources, providers and result sinks."""
