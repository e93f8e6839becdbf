"""sayframe: speech-text preparation as DataFrame operations."""
