"""File sources, sinks and stored state."""
