"""Reverse-mode derivatives of code written for numpy arrays.

A ``Traced`` array answers numpy's dispatch protocols: functions that know
nothing of it compute the same values, while every step notes how a change of
its result goes back to its inputs. Only what the network and its losses use is
covered; anything else is an error rather than a missing derivative.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Back = Callable[[np.ndarray], np.ndarray]

_UFUNCS: dict[np.ufunc, Callable] = {}
_FUNCTIONS: dict[Callable, Callable] = {}


def value_of(x):
    return x.value if isinstance(x, Traced) else x


def _shrink(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sums away what broadcasting had repeated."""
    grad = grad.sum(axis=tuple(range(grad.ndim - len(shape))))
    repeated = tuple(i for i, n in enumerate(shape) if n == 1 and grad.shape[i] != 1)
    return grad.sum(axis=repeated, keepdims=True) if repeated else grad


class Traced(np.lib.mixins.NDArrayOperatorsMixin):
    """A value and the steps back to what it was made of."""

    def __init__(self, value: np.ndarray, sources: list[tuple[Traced, Back]] | None = None):
        self.value, self.sources, self.grad = np.asarray(value), sources or [], None

    shape = property(lambda self: self.value.shape)
    ndim = property(lambda self: self.value.ndim)
    dtype = property(lambda self: self.value.dtype)
    T = property(lambda self: self.transpose())

    def __len__(self) -> int:
        return len(self.value)

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **settings):
        # ``a += traced`` asks for an output array; the traced sum takes the name's place instead.
        if method != "__call__" or ufunc not in _UFUNCS or settings:
            return NotImplemented
        values = [value_of(x) for x in inputs]
        result = ufunc(*values)
        backs = _UFUNCS[ufunc](result, *values)
        shapes = [np.shape(v) for v in values]
        return Traced(result, [(x, lambda g, b=b, s=s, u=ufunc: b(g) if u is np.matmul else _shrink(b(g), s)) for x, b, s in zip(inputs, backs, shapes, strict=True) if isinstance(x, Traced)])

    def __array_function__(self, function, types, args, kwargs):
        if function not in _FUNCTIONS:
            return NotImplemented
        return _FUNCTIONS[function](*args, **kwargs)

    def __getitem__(self, at) -> Traced:
        def back(g):
            out = np.zeros(self.shape, g.dtype)
            np.add.at(out, at, g)
            return out

        plain = all(isinstance(i, (int, slice, type(None), type(...))) for i in (at if isinstance(at, tuple) else (at,)))

        def back_plain(g):
            out = np.zeros(self.shape, g.dtype)
            out[at] = g
            return out

        return Traced(self.value[at], [(self, back_plain if plain else back)])

    def reshape(self, *shape) -> Traced:
        return Traced(self.value.reshape(*shape), [(self, lambda g: g.reshape(self.shape))])

    def ravel(self) -> Traced:
        return self.reshape(-1)

    def transpose(self, *axes) -> Traced:
        back = np.argsort(axes) if axes else None
        return Traced(self.value.transpose(*axes), [(self, lambda g: g.transpose(back))])

    def astype(self, kind) -> Traced:
        return Traced(self.value.astype(kind), [(self, lambda g: g)])

    def sum(self, axis=None, keepdims: bool = False) -> Traced:
        def back(g):
            return np.broadcast_to(g if axis is None or keepdims else np.expand_dims(g, axis), self.shape)

        return Traced(self.value.sum(axis=axis, keepdims=keepdims), [(self, back)])

    def mean(self, axis=None, keepdims: bool = False) -> Traced:
        total = self.sum(axis, keepdims)
        return total * total.dtype.type(total.value.size / max(self.value.size, 1))

    def var(self, axis=None, keepdims: bool = False) -> Traced:
        apart = self - self.mean(axis, keepdims=True)
        return (apart * apart).mean(axis, keepdims)

    def max(self, axis=None, keepdims: bool = False) -> Traced:
        """Entries that tie for the greatest share its derivative alike."""
        top = self.value.max(axis=axis, keepdims=True)
        hit = self.value == top
        share = hit / hit.sum(axis=axis, keepdims=True).astype(self.dtype)

        def back(g):
            return share * (g if axis is None or keepdims else np.expand_dims(g, axis))

        return Traced(top if keepdims else self.value.max(axis=axis), [(self, back)])

    def backward(self) -> None:
        """Sets ``grad`` on everything this number was made of."""
        order: list[Traced] = []
        seen: set[int] = set()
        waiting: list[tuple[Traced, bool]] = [(self, False)]
        while waiting:
            x, done = waiting.pop()
            if done:
                order.append(x)
            elif id(x) not in seen:
                seen.add(id(x))
                waiting += [(x, True), *((s, False) for s, _ in x.sources)]
        self.grad = np.ones_like(self.value)
        for x in reversed(order):
            for source, back in x.sources:
                g = back(x.grad)
                source.grad = g if source.grad is None else source.grad + g
            if x.sources and x is not self:
                x.grad = None


def _matmul_backs(y, a, b):
    turned = lambda z: np.swapaxes(z, -1, -2)
    if np.ndim(b) == 2:  # the sum over all leading places is one product
        return lambda g: g @ b.T, lambda g: a.reshape(-1, a.shape[-1]).T @ g.reshape(-1, g.shape[-1])
    return lambda g: _shrink(g @ turned(b), np.shape(a)), lambda g: _shrink(turned(a) @ g, np.shape(b))


_UFUNCS |= {
    np.add: lambda y, a, b: (lambda g: g, lambda g: g),
    np.subtract: lambda y, a, b: (lambda g: g, lambda g: -g),
    np.multiply: lambda y, a, b: (lambda g: g * b, lambda g: g * a),
    np.divide: lambda y, a, b: (lambda g: g / b, lambda g: -g * y / b),
    np.negative: lambda y, a: (lambda g: -g,),
    np.exp: lambda y, a: (lambda g: g * y,),
    np.log: lambda y, a: (lambda g: g / a,),
    np.logaddexp: lambda y, a, b: (lambda g: g * np.exp(a - y), lambda g: g * np.exp(b - y)),
    np.sqrt: lambda y, a: (lambda g: g / (2 * y),),
    np.absolute: lambda y, a: (lambda g: g * np.sign(a),),
    np.maximum: lambda y, a, b: (lambda g: g * (a > b), lambda g: g * (b > a)),
    np.matmul: _matmul_backs,
}


def _covers(function):
    return lambda f: _FUNCTIONS.__setitem__(function, f) or f


@_covers(np.pad)
def _pad(x, width, mode="constant"):
    if mode != "constant":
        raise TypeError("only padding with zeros has a derivative here")
    inner = tuple(slice(a, a + n) for (a, _), n in zip(width, x.shape, strict=True))
    return Traced(np.pad(x.value, width), [(x, lambda g: g[inner])])


@_covers(np.concatenate)
def _concatenate(parts, axis=0):
    values = [value_of(p) for p in parts]
    ends = np.cumsum([v.shape[axis] for v in values])[:-1]
    backs = [(p, lambda g, i=i: np.split(g, ends, axis=axis)[i]) for i, p in enumerate(parts) if isinstance(p, Traced)]
    return Traced(np.concatenate(values, axis=axis), backs)


@_covers(np.stack)
def _stack(parts, axis=0):
    backs = [(p, lambda g, i=i: np.take(g, i, axis=axis)) for i, p in enumerate(parts) if isinstance(p, Traced)]
    return Traced(np.stack([value_of(p) for p in parts], axis=axis), backs)


@_covers(np.split)
def _split(x, count, axis=0):
    size = x.shape[axis] // count
    at = lambda i: (*[slice(None)] * (axis % x.ndim), slice(i * size, (i + 1) * size))
    return [x[at(i)] for i in range(count)]


@_covers(np.einsum)
def _einsum(form, *parts, optimize=True):
    """The derivative by one factor is the product of the result's and the other factors; each letter must be in one of these."""
    given, made = form.split("->")
    names = given.split(",")
    values = [value_of(p) for p in parts]

    def back(i):
        others = [*names[:i], *names[i + 1 :]]
        turned = ",".join([made, *others]) + "->" + names[i]
        return lambda g: np.einsum(turned, g, *values[:i], *values[i + 1 :], optimize=True)

    backs = [(p, back(i)) for i, p in enumerate(parts) if isinstance(p, Traced)]
    return Traced(np.einsum(form, *values, optimize=optimize), backs)
