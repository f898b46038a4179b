"""File sources of the engine."""
