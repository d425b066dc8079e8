"""Powers and products modulo an odd number, used inside tasks.

They run in OpenSSL's libcrypto, the library behind Python's hashlib, where the system has it as a shared library; otherwise in Python's
integers, with the same results at several times the cost. An object serves one thread and is built in the task that uses it.
"""

from __future__ import annotations

import ctypes
import weakref

_NAMES = ("libcrypto.so.3", "libcrypto.so.1.1")
_P, _N = ctypes.c_void_p, ctypes.c_int
_CALLS = {  # result, arguments
    "BN_new": (_P, []),
    "BN_bin2bn": (_P, [ctypes.c_char_p, _N, _P]),
    "BN_bn2binpad": (_N, [_P, ctypes.c_char_p, _N]),
    "BN_clear_free": (None, [_P]),
    "BN_CTX_new": (_P, []),
    "BN_CTX_free": (None, [_P]),
    "BN_MONT_CTX_new": (_P, []),
    "BN_MONT_CTX_set": (_N, [_P] * 3),
    "BN_MONT_CTX_free": (None, [_P]),
    "BN_to_montgomery": (_N, [_P] * 4),
    "BN_from_montgomery": (_N, [_P] * 4),
    "BN_mod_mul_montgomery": (_N, [_P] * 5),
    "BN_mod_exp_mont_consttime": (_N, [_P] * 6),
}


def library() -> ctypes.CDLL | None:
    """Opened anew by each call: a cached function would travel by its name, which workers without the package cannot import."""
    for name in _NAMES:
        try:
            lib = ctypes.CDLL(name)
            for call, (result, arguments) in _CALLS.items():
                getattr(lib, call).restype, getattr(lib, call).argtypes = result, arguments
        except (OSError, AttributeError):
            continue
        return lib
    return None


def _checked(result):
    if not result:
        raise MemoryError("libcrypto failed")
    return result


def _free(lib: ctypes.CDLL, numbers: list[int], context: int, mont: int) -> None:
    for number in numbers:
        lib.BN_clear_free(number)
    lib.BN_MONT_CTX_free(mont)
    lib.BN_CTX_free(context)


class _Modulus:
    def __init__(self, modulus: int):
        self.modulus, self.size, self.lib = modulus, -(-modulus.bit_length() // 8), library()
        if self.lib is None:
            return
        self.context, self.mont, self.numbers = _checked(self.lib.BN_CTX_new()), _checked(self.lib.BN_MONT_CTX_new()), []
        weakref.finalize(self, _free, self.lib, self.numbers, self.context, self.mont)
        self.m, self.held = self.number(modulus), self.number(0)
        self.text = ctypes.create_string_buffer(self.size)
        _checked(self.lib.BN_MONT_CTX_set(self.mont, self.m, self.context))

    def number(self, x: int) -> int:
        """A number of the library that lives as long as this object."""
        digits = x.to_bytes(max(1, -(-x.bit_length() // 8)), "big")
        self.numbers.append(_checked(self.lib.BN_bin2bn(digits, len(digits), None)))
        return self.numbers[-1]

    def result(self) -> int:
        if self.lib.BN_bn2binpad(self.held, self.text, self.size) != self.size:
            raise MemoryError("libcrypto failed")
        return int.from_bytes(self.text.raw, "big")


class FixedExponent(_Modulus):
    """``x ** exponent`` for many x and one secret exponent, in time that does not tell its bits where the library is there."""

    def __init__(self, modulus: int, exponent: int):
        super().__init__(modulus)
        self.exponent = exponent
        if self.lib is not None:
            self.e, self.x = self.number(exponent), self.number(0)

    def __call__(self, x: int) -> int:
        if self.lib is None:
            return pow(x, self.exponent, self.modulus)
        _checked(self.lib.BN_bin2bn((x % self.modulus).to_bytes(self.size, "big"), self.size, self.x))
        _checked(self.lib.BN_mod_exp_mont_consttime(self.held, self.x, self.e, self.m, self.context, self.mont))
        return self.result()


class FixedBase(_Modulus):
    """``base ** exponent`` for one base and many exponents of a given number of bytes, the product of one table entry for each byte."""

    def __init__(self, modulus: int, base: int, length: int):
        super().__init__(modulus)
        self.rows = []
        for _ in range(length):
            row = [1]
            for _ in range(255):
                row.append(row[-1] * base % modulus)
            base = row[-1] * base % modulus
            self.rows.append(row if self.lib is None else [self._entry(x) for x in row])

    def _entry(self, x: int) -> int:
        entry = self.number(x)
        _checked(self.lib.BN_to_montgomery(entry, entry, self.mont, self.context))
        return entry

    def __call__(self, exponent: bytes) -> int:
        """``exponent`` has its low byte first."""
        entries = [row[digit] for row, digit in zip(self.rows, exponent, strict=True)]
        if self.lib is None:
            product = 1
            for x in entries:
                product = product * x % self.modulus
            return product
        multiply, held, mont, context = self.lib.BN_mod_mul_montgomery, self.held, self.mont, self.context
        product, done = entries[0], 1
        for x in entries[1:]:
            done += multiply(held, product, x, mont, context)
            product = held
        _checked(done == len(entries))
        _checked(self.lib.BN_from_montgomery(held, product, mont, context))
        return self.result()
