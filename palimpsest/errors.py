"""Errors of the driver side. Errors of single pages are columns, never exceptions of a job."""


class PipelineError(Exception):
    """Base of all errors raised here."""


class ConfigError(PipelineError):
    """A setting, format or name that is not known."""


class EngineError(PipelineError):
    def __init__(self, message: str, engine_name: str = "") -> None:
        super().__init__(message)
        self.engine_name = engine_name


class SizeError(PipelineError):
    """A file of refused size."""


class CheckpointError(PipelineError):
    """State that cannot be read or written."""


class RenderError(PipelineError):
    """A page that cannot be made."""


class MergeError(PipelineError):
    """A merge of transcriptions that failed after all retries."""
