"""What can go wrong, as exceptions. Their names double as error_class values in quarantine tables."""


class StreamError(RuntimeError):
    """Any failure of the codec."""


class CorruptedStream(StreamError):
    """Bytes that are not a valid frame, record, chunk or container."""


class DeprecatedWireFormat(CorruptedStream):
    """An indexed frame of a wire version whose index had no settled layout."""


class UnsupportedWireFormat(CorruptedStream):
    """A wire version outside the readable window."""


class RateBudgetExceeded(StreamError):
    """Fixed framing alone does not fit the requested rate."""
