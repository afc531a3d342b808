"""The one error that the engine raises for its own refusals."""

from __future__ import annotations

#: Codes of refusals (fixed values).
CODES = (
    "not_found", "not_zarr", "unsupported_transport", "unsupported_zarr_version", "unsupported_schema",
    "unsupported_schema_version", "ambiguous_schema", "invalid_schema", "invalid_argument", "invalid_metadata",
    "unsupported_data_type", "unsupported_codec", "invalid_slice", "buffer_too_small", "io_error", "decode_error",
    "cancelled", "not_implemented",
)


class CubeError(Exception):
    """A refusal: code (one of CODES), what was wrong, and the node it concerns."""

    def __init__(self, code: str, message: str, node_path: str = ""):
        if code not in CODES:
            raise ValueError(f"unknown code {code!r}")
        super().__init__(f"{code}: {message}" + (f" ({node_path})" if node_path else ""))
        self.code, self.message, self.node_path = code, message, node_path

    def __reduce__(self):
        return CubeError, (self.code, self.message, self.node_path)
