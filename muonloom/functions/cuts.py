"""Event selections.  Every cut is a boolean Column over booked event columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from muonloom.functions.guards import between
from muonloom.functions.shapes import balloon_line
from muonloom.sources.constants import INFILL_STATIONS, PDG


def _c(name_or_col) -> Column:
    return F.col(name_or_col) if isinstance(name_or_col, str) else name_or_col


def trigger(filt="filt") -> Column:
    return _c(filt)


def training(qsum2_limit: float = 0.95, filt="filt", qsum2="qsum2",
             qtotalhlc="qtotalhlc") -> Column:
    """Events used to train the geometry forests."""
    return _c(filt) & (_c(qsum2) <= qsum2_limit * _c(qtotalhlc))


def energy_training(qsum2_limit: float = 0.9, cos_lo: float = 0.8, cos_hi: float = 1.0,
                    zenith="zenith") -> Column:
    """Events used to train the energy forest."""
    return (training(qsum2_limit) & _c("loud_sta")
            & between(F.cos(_c(zenith)), cos_lo, cos_hi))


def quality(cos_lo: float = 0.9, cos_hi: float = 1.0, zenith="zenith", max_nsta: int = 42,
            log_q=(-0.2, 3.8), qmax_limit: float = 0.75, qsum2_limit: float = 0.9) -> Column:
    """Analysis cuts, for simulation and data alike."""
    q = _c("qtotalhlc")
    return (
        between(F.cos(_c(zenith)), cos_lo, cos_hi)
        & (_c("nsta") <= max_nsta)
        & between(q, 10.0 ** log_q[0], 10.0 ** log_q[1])
        & (_c("qmax") <= qmax_limit * q)
        & (_c("qsum2") <= qsum2_limit * q)
    )


def balloon(qhillas="qhillas", qtotal="qtotal") -> Column:
    """Keep events whose charge is not concentrated in one tank."""
    return F.log10(_c(qhillas)) >= balloon_line(F.log10(_c(qtotal)))


def multiplicity(max_nsta=50, max_nslc=40, max_ntanks=112, max_qtotal=1e4) -> Column:
    return ((_c("nsta") <= max_nsta) & (_c("nslc") <= max_nslc)
            & (_c("ntanks") <= max_ntanks) & (_c("qtotal") <= max_qtotal))


def all_of(*flags) -> Column:
    out = F.lit(True)
    for f in flags:
        out = out & _c(f)
    return out


def physics_substream(stream="sub_event_stream") -> Column:
    """First sub-event, filter passed, loudest station in the infill."""
    return (_c(stream) == 0) & _c("filt") & _c("loud_sta")


def particle(name: str, pdg="pdg") -> Column:
    return _c(pdg) == PDG[name]


def energy_window(log_energy, lo: float = 5.4, hi: float = 7.0) -> Column:
    return between(_c(log_energy), lo, hi)


def infill(station) -> Column:
    return _c(station).isin(*INFILL_STATIONS)


def pulse_threshold(charge="charge", limit: float = 0.8, inclusive: bool = False) -> Column:
    return _c(charge) >= limit if inclusive else _c(charge) > limit
