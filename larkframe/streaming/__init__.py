"""The engine answers batch queries only; it has no streaming operators."""
