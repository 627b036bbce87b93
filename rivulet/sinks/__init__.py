from .dispatch import Batch, CaptureSink, DelegateSink, DeliveryError, Sink, dispatch  # noqa: F401
from .remote import BulkSink, HttpSink, IndexSink, KafkaSink, Request, Response  # noqa: F401
from .tables import TableSink, VectorSink  # noqa: F401
