"""Parameter files written and read back, and minor profiles of one set grafted into another."""

import numpy as np

from codonlake.sources import params
from tests.test_signals import small_parameters, two_isochores
from tests.test_splice import minor_parameters


def same(a, b):
    assert (a.no_score, a.rules, len(a.isochores)) == (b.no_score, b.rules, len(b.isochores))
    for x, y in zip(a.isochores, b.isochores, strict=True):
        assert (x.low, x.high, x.values, x.word, x.donors, list(x.profiles)) == (y.low, y.high, y.values, y.word, y.donors, list(y.profiles))
        assert np.array_equal(x.initial, y.initial) and np.array_equal(x.transition, y.transition)
        for f, g in zip(x.profiles.values(), y.profiles.values(), strict=True):
            assert (f.dimension, f.offset, f.cutoff, f.order, f.a, f.b, tuple(f.extra)) == (g.dimension, g.offset, g.cutoff, g.order, g.a, g.b, tuple(g.extra))
            assert np.array_equal(f.weights, g.weights)


def test_round_trip():
    for p in (params.parse(small_parameters()), two_isochores(), minor_parameters()):
        same(params.parse(params.text(p), blanks_block=False), p)


def test_graft():
    p, other = params.parse(small_parameters()), minor_parameters()
    got = params.grafted(p, other).isochores[0]
    assert [k for k in got.profiles if k.startswith("U12")] == [k for k in other.isochores[0].profiles if k.startswith("U12") and not k.endswith("Donor_profile")] + [k for k in other.isochores[0].profiles if k.startswith("U12") and k.endswith("Donor_profile")]
    assert got.profiles["Acceptor_profile"] is p.isochores[0].profiles["Acceptor_profile"]
    assert got.values["U12_Exon_weight"] == [2.5] and got.values["Site_factor"] == p.isochores[0].values["Site_factor"]
    order = list(got.profiles)
    assert order.index("U12gtag_Acceptor_profile") < order.index("Acceptor_profile") and order.index("U12gtag_Donor_profile") < order.index("Donor_profile")
    same(params.parse(params.text(params.grafted(p, other)), blanks_block=False), params.grafted(p, other))
