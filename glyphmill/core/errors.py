"""Errors, each with a kind; all are raised while loading, none while encoding."""


class _Kinded(ValueError):
    def __init__(self, kind: str, message: str = "") -> None:
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind

    def __reduce__(self):
        return type(self), (self.kind, str(self))


class TokenizerError(_Kinded):
    """invalidConfiguration, unsupportedComponent, missingVocab, tooLong, missingChatTemplate and the like."""


class ResponseParsingError(_Kinded):
    """Of response templates and the text parsed by them."""


class JSONConfigError(_Kinded):
    """Of the JSON reader."""
