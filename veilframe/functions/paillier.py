"""Additively homomorphic numbers: the per-value arithmetic used inside tasks.

Values are fixed-point integers ``round(x * 2^bits)`` modulo n; negatives are ``n - |m|``. The random factor of an
encryption is a short power of a fixed n-th power (Damgard, Jurik, Nielsen 2010), read from a table of digit powers.
"""

from __future__ import annotations

import random
import secrets
from dataclasses import dataclass

from veilframe.functions.modular import FixedBase, FixedExponent

SCALE_BITS = 128  # doubles above 1e-22 in size are represented exactly


@dataclass(frozen=True)
class PublicKey:
    n: int

    def to_wire(self) -> dict[str, str]:
        return {"n": str(self.n)}

    @staticmethod
    def from_wire(payload: dict[str, str]) -> PublicKey:
        if not isinstance(payload, dict):
            raise TypeError("a public key travels as {'n': digits}")
        return PublicKey(int(payload["n"]))


@dataclass(frozen=True)
class PrivateKey:
    p: int
    q: int

    @property
    def public(self) -> PublicKey:
        return PublicKey(self.p * self.q)


def generate_keypair(bits: int = 2048, seed: int | None = None) -> PrivateKey:
    """Key with an n of exactly ``bits`` bits; ``seed`` gives a repeatable key for tests only."""
    rng = secrets.SystemRandom() if seed is None else random.Random(seed)
    while True:
        p, q = _prime(bits // 2, rng), _prime(bits - bits // 2, rng)
        if p != q and (p * q).bit_length() == bits:
            return PrivateKey(p, q)


def _prime(bits: int, rng: random.Random) -> int:
    while True:
        candidate = rng.getrandbits(bits) | (3 << (bits - 2)) | 3
        if _probably_prime(candidate, rng):
            return candidate


def _probably_prime(n: int, rng: random.Random, rounds: int = 40) -> bool:
    if any(n % s == 0 for s in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for _ in range(rounds):
        x = pow(rng.randrange(2, n - 1), odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


@dataclass(frozen=True)
class Packing:
    """Several fixed-point numbers in one plaintext, ``width`` bits apart, so that one encryption and one decryption serve them all.

    A slot has room for the sign, numbers up to ``largest`` and sums of up to ``weight`` of them; built by ``packing``, which checks this.
    """

    slots: int
    width: int
    bits: int
    largest: float

    def pack(self, values: dict[int, float]) -> int:
        total = 0
        for slot, x in values.items():
            if abs(x) > self.largest:
                raise OverflowError("value too large for its slot")
            total += int(round(x * (1 << self.bits))) << (slot * self.width)
        return total

    def unpack(self, m: int) -> list[int]:
        """The signed sums of all slots; a negative one has borrowed from the next."""
        half, out = 1 << (self.width - 1), []
        for _ in range(self.slots):
            low = ((m + half) & ((1 << self.width) - 1)) - half
            out.append(low)
            m = (m - low) >> self.width
        return out


def packing(key: PublicKey, largest: float, weight: int = 1, bits: int = 64) -> Packing:
    """As many slots as the key holds for numbers up to ``largest`` in size, ``bits`` after the point, summed with weights up to ``weight`` in total."""
    width = bits + max(1, int(largest).bit_length() + 1) + max(1, int(weight)).bit_length() + 1
    slots = (key.n.bit_length() - 3) // width
    if slots < 1:
        raise OverflowError("the key is too short for these numbers and weights")
    return Packing(slots, width, bits, largest)


class Encryptor:
    """Encrypts many numbers under one public key; build one per task."""

    def __init__(self, key: PublicKey, bits: int = SCALE_BITS):
        self.n, self.square, self.bits = key.n, key.n * key.n, bits
        base = pow(secrets.randbelow(self.n - 2) + 2, 2 * self.n, self.square)
        self.digits = -(-self.n.bit_length() // 16)  # bytes of half the key's length
        self.blind = FixedBase(self.square, base, self.digits)

    def encrypt(self, x: float) -> int:
        return self.encrypt_integer(int(round(x * (1 << self.bits))))

    def encrypt_integer(self, m: int) -> int:
        if 3 * abs(m) >= self.n:
            raise OverflowError("value too large for this key")
        return (1 + m % self.n * self.n) * self.blind(secrets.token_bytes(self.digits)) % self.square


class Decryptor:
    """Decrypts by the two prime halves of the key."""

    def __init__(self, key: PrivateKey, bits: int = SCALE_BITS):
        self.p, self.q, self.n, self.bits = key.p, key.q, key.p * key.q, bits
        self.hp, self.hq = self._h(self.p), self._h(self.q)
        self.q_inverse = pow(self.q, -1, self.p)
        self.by_p, self.by_q = FixedExponent(self.p * self.p, self.p - 1), FixedExponent(self.q * self.q, self.q - 1)

    def _h(self, prime: int) -> int:
        return pow(self._log(pow(1 + self.n, prime - 1, prime * prime), prime), -1, prime)

    @staticmethod
    def _log(x: int, prime: int) -> int:
        return (x - 1) // prime

    def decrypt(self, c: int) -> int:
        """Signed fixed-point integer; a result in the middle third of the range means an overflowed sum."""
        mp = self._log(self.by_p(c), self.p) * self.hp % self.p
        mq = self._log(self.by_q(c), self.q) * self.hq % self.q
        m = mq + (mp - mq) * self.q_inverse % self.p * self.q
        if 3 * m < self.n:
            return m
        if 3 * m > 2 * self.n:
            return m - self.n
        raise OverflowError("encrypted sum left the range of the key")

    def value(self, c: int, divisor: int = 1) -> float:
        return self.decrypt(c) / (divisor << self.bits)
