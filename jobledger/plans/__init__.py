"""The user-facing reports. Each is one DataFrame graph over the operators; sinks are optional arguments."""
