"""Live metric cards with Structured Streaming."""
