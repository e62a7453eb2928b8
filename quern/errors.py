"""Errors that gates, readers and endpoints raise."""


class QuernError(Exception):
    """Base of all errors of this package."""


class InvalidRecord(QuernError):
    """A record breaks the schema or an invariant."""


class DuplicateKey(InvalidRecord):
    """A key that must be unique occurs twice."""


class UnknownValue(InvalidRecord):
    """A value outside its closed space: a split, a label, a strategy, a file name."""


class MissingField(InvalidRecord):
    """A field that must be there is missing or blank."""


class ChoiceStructure(InvalidRecord):
    """A multiple-choice record whose options and answer don't agree."""


class UnsafeTrace(InvalidRecord):
    """A trace that may not be published as it is."""


class GateFailed(QuernError):
    """A gate's expectations don't hold."""


class CallError(QuernError):
    """A call of a model failed."""

    #: Whether another try may help.
    transient = True


class CallTimeout(CallError):
    """No answer in time."""


class CallRefused(CallError):
    """The endpoint does not accept the caller (401, 403)."""

    transient = False


class EndpointFailed(CallError):
    """The endpoint failed by itself (5xx)."""


class AnswerUnreadable(CallError):
    """The answer is not of the expected shape."""

    transient = False
