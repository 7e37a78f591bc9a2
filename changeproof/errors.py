"""Refusals. Each carries the code a caller can branch on."""


class Refused(ValueError):
    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message} {details or ''}".strip())
        self.code = code
        self.details = details
