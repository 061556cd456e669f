"""A one-node matrix product as ONNX bytes.

Written field by field in the protobuf wire format, since no ONNX writer is
assumed: a model with one graph, one MatMul node and one weight tensor.
"""

from __future__ import annotations

import struct

DOUBLE = 11  # Fixed value: ONNX element type of a 64-bit float.


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append((n & 0x7F) | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _value(name: str, width: int) -> bytes:
    shape = _bytes(1, _bytes(2, "batch")) + _bytes(1, _number(1, width))
    tensor = _number(1, DOUBLE) + _bytes(2, shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, tensor))


def weight(row: int, column: int) -> float:
    """Small deterministic weights, easy to state in SQL."""
    return ((row * 7 + column * 3) % 11 - 5) / 10


def matmul_model(width_in: int, width_out: int) -> bytes:
    weights = [weight(i, j) for i in range(width_in) for j in range(width_out)]
    tensor = (
        _number(1, width_in)
        + _number(1, width_out)
        + _number(2, DOUBLE)
        + _bytes(8, "weights")
        + _bytes(9, struct.pack(f"<{len(weights)}d", *weights))
    )
    node = _bytes(1, "vector") + _bytes(1, "weights") + _bytes(2, "latent") + _bytes(4, "MatMul")
    graph = (
        _bytes(1, node)
        + _bytes(2, "projection")
        + _bytes(5, tensor)
        + _bytes(11, _value("vector", width_in))
        + _bytes(12, _value("latent", width_out))
    )
    opset = _number(2, 13)
    return _number(1, 8) + _bytes(7, graph) + _bytes(8, opset)
