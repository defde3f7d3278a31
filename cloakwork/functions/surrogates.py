"""Keyed, deterministic, reversible surrogate tokens as column expressions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions import fixed

_BASE32_DIGITS = "0123456789abcdefghijklmnopqrstuv"
_BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def hmac_sha256(message: Column, key: str) -> Column:
    """Hex HMAC-SHA256 of a binary or string column, from two built-in ``sha2`` calls."""
    raw = key.encode()
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in raw)
    outer = bytes(b ^ 0x5C for b in raw)
    digest = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def length_prefixed(*fields: Column) -> Column:
    """Unambiguous binary encoding: each field behind its 4-byte big-endian byte length."""
    parts = []
    for field in fields:
        data = field.cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data]
    return F.concat(*parts)


def base32_tag(digest_hex: Column) -> Column:
    """First 12 base-32 characters (60 bits) of a hex digest."""
    digits = F.lower(F.conv(F.substring(digest_hex, 1, 15), 16, 32))
    return F.translate(F.lpad(digits, fixed.ENTITY_TAG_LEN, "0"), _BASE32_DIGITS, _BASE32_LETTERS)


@dataclass(frozen=True)
class Surrogates:
    """Token formats for one key and prefix.

    ``style`` is ``opaque`` (prefix and hex) or ``typed`` (a short category in between).
    A subclass with other ``mint`` and ``pattern`` is a custom strategy.
    """

    key: str
    style: str = "typed"
    prefix: str = fixed.DEFAULT_PREFIX

    # ------------------------------------------------------------------ minting
    def digest(self, value: Column) -> Column:
        return F.substring(hmac_sha256(value, self.key), 1, fixed.HEX_LEN)

    def mint_opaque(self, value: Column) -> Column:
        return F.concat(F.lit(self.prefix), self.digest(value))

    def type_of(self, name: Column, kind: Column) -> Column:
        """Token type: mapped category, else coarse kind; an arbitrary label never shows."""
        wanted = F.lower(name)
        by_type: dict[str, list[str]] = {}
        for category, token_type in fixed.CATEGORY_TYPE.items():
            by_type.setdefault(token_type, []).append(category)
        out = F.when(F.lit(False), F.lit(""))
        for token_type, categories in by_type.items():
            out = out.when(wanted.isin(categories), F.lit(token_type))
        for coarse, token_type in fixed.KIND_TYPE.items():
            out = out.when(kind == coarse, F.lit(token_type))
        return out.otherwise(F.lit(fixed.FALLBACK_TYPE))

    def mint_typed(self, value: Column, name: Column, kind: Column) -> Column:
        return F.concat(F.lit(self.prefix), self.type_of(name, kind), F.lit("_"), self.digest(value))

    def mint(self, value: Column, name: Column, kind: Column) -> Column:
        return self.mint_typed(value, name, kind) if self.style == "typed" else self.mint_opaque(value)

    def entity_tag(self, context: Column, entity_id: Column) -> Column:
        payload = length_prefixed(F.lit("cloak.entity.v1"), context, entity_id)
        return base32_tag(hmac_sha256(payload, self.key))

    def surface_tag(self, context: Column, entity_id: Column, surface: Column) -> Column:
        payload = length_prefixed(F.lit("cloak.surface.v1"), context, entity_id, surface)
        return base32_tag(hmac_sha256(payload, self.key))

    def mint_entity(self, context: Column, entity_id: Column, entity_type: Column, surface: Column) -> Column:
        """Context-bound family token: one entity tag per identity, one surface tag per spelling."""
        return F.concat(
            F.lit(self.prefix),
            F.when(entity_type == "organization", "ORG").otherwise("PERSON"),
            F.lit("_"), self.entity_tag(context, entity_id),
            F.lit("_"), self.surface_tag(context, entity_id, surface),
        )

    # ----------------------------------------------------------------- patterns
    @property
    def _tag(self) -> str:
        return f"[A-Z2-7]{{{fixed.ENTITY_TAG_LEN}}}"

    @property
    def opaque_pattern(self) -> str:
        return f"{self.prefix}[0-9a-f]{{{fixed.HEX_LEN}}}"

    @property
    def typed_pattern(self) -> str:
        return f"{self.prefix}[A-Z0-9]{{1,{fixed.MAX_TYPE_LEN}}}_[0-9a-f]{{{fixed.HEX_LEN}}}"

    @property
    def entity_pattern(self) -> str:
        return f"{self.prefix}(?:ORG|PERSON)_{self._tag}_{self._tag}"

    @property
    def pattern(self) -> str:
        """One complete token of the active style, or an entity-family token."""
        literal = self.typed_pattern if self.style == "typed" else self.opaque_pattern
        return f"(?:{literal}|{self.entity_pattern})"

    @property
    def residual_pattern(self) -> str:
        """Any token-shaped run of any style, complete entity tokens before their fragments."""
        fragment = (
            f"{self.prefix}(?:ORG|PERSON)_{self._tag}"
            f"(?:_(?!{self._tag})|(?![0-9A-Za-z_]))"
        )
        return f"(?:{self.entity_pattern}|{fragment}|{self.typed_pattern}|{self.opaque_pattern})"

    @property
    def partial_pattern(self) -> str:
        """A text tail that may be the beginning of a token (anchored at the end)."""
        literal = "".join(f"(?:{c}" for c in self.prefix[1:]) + ")?" * (len(self.prefix) - 1)
        hex_part = f"[0-9a-f]{{0,{fixed.HEX_LEN - 1}}}"
        typed = f"[A-Z0-9]{{0,{fixed.MAX_TYPE_LEN}}}(?:_{hex_part})?"
        body = typed if self.style == "typed" else hex_part
        family = "|".join(
            f"{name[:i]}" for name in ("ORG_", "PERSON_") for i in range(1, len(name))
        )
        tag = f"[A-Z2-7]{{0,{fixed.ENTITY_TAG_LEN - 1}}}"
        entity = f"(?:ORG|PERSON)_(?:{tag}|{self._tag}(?:_{tag})?)"
        return f"(?:{self.prefix}(?:{body}|{family}|{entity})|{self.prefix[0]}{literal})$"

    @property
    def max_length(self) -> int:
        entity = len(f"{self.prefix}PERSON__") + 2 * fixed.ENTITY_TAG_LEN
        typed = len(self.prefix) + fixed.MAX_TYPE_LEN + 1 + fixed.HEX_LEN
        opaque = len(self.prefix) + fixed.HEX_LEN
        return max(entity, typed if self.style == "typed" else opaque)
