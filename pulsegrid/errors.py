"""Errors a caller can act on."""


class InvalidArgument(ValueError):
    """A required argument is missing or malformed."""


class TelemetryNotFound(LookupError):
    """A well-formed query matched no telemetry."""

    def __init__(self, gpu_id: str):
        super().__init__(f"no telemetry data found for gpu_id: {gpu_id}")
        self.gpu_id = gpu_id


class TopicExists(ValueError):
    """The topic name is taken."""


class TopicNotFound(LookupError):
    """No topic has this name."""


class PartitionOutOfRange(IndexError):
    """The topic has no such partition."""


class OffsetOutOfRange(IndexError):
    """The offset is outside the partition."""
