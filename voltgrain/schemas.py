"""Declared schemas of the domain tables; loads never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _L, _I, _S, _B = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
_AD, _AI, _AS = T.ArrayType(_D), T.ArrayType(_I), T.ArrayType(_S)


def _s(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


SCHEMAS: dict[str, T.StructType] = {
    "trace_meta": _s(trace_id=_S, time_scale=_D, time_unit=_S, time_max=_L),
    "signals": _s(sig_id=_S, scope=_AS, name=_S, type=_S, width=_I, msb=_I, lsb=_I),
    "events": _s(sig_id=_S, bit=_I, t=_L, seq=_L, v=_I),
    "insts": _s(inst_id=_L, path=_S, path_parts=_AS, cell_name=_S, is_leaf=_B),
    "pins": _s(pin_id=_L, inst_id=_L, port=_S, dir=_S, net_id=_L, pin_idx=_I, is_clock=_B),
    "nets": _s(net_id=_L, path=_S),
    "cells": _s(cell_name=_S, lib=_S, area=_D, is_macro=_B, is_memory=_B, interface_timing=_B, is_pad=_B,
                has_seq=_B, is_clock_gate=_B, dont_use=_B, default_leakage=_D, default_exists=_B),
    "ports": _s(cell_name=_S, port=_S, dir=_S, function=_S, cap_rise=_D, cap_fall=_D, related_pg=_S,
                max_slew=_D, max_cap=_D, max_fanout=_D, fanout_load=_D),
    "leakage": _s(cell_name=_S, ord=_I, when=_S, care_mask=_I, value_mask=_I, power=_D),
    "int_power": _s(cell_name=_S, port=_S, related_port=_S, ord=_I, when=_S, pg_pin=_S, rf=_S, axis1_var=_S,
                    axis1=_AD, axis2_var=_S, axis2=_AD, vals=_AD),
    "lib_arcs": _s(cell_name=_S, from_port=_S, to_port=_S, role=_S, sense=_S, from_rf=_S, to_rf=_S, cond=_S,
                   axis1=_AD, axis2=_AD, delay=_AD, slew=_AD),
    "edges": _s(e_id=_L, from_v=_L, to_v=_L, role=_S, from_rf=_S, to_rf=_S, corner=_S, d_min=_L, d_max=_L),
    "activity": _s(pin_id=_L, activity=_D, duty=_D, origin=_S),
    "clocks": _s(clk=_S, period=_D, waveform=_AD, src_pins=_AS, master=_S, divide_by=_I, multiply_by=_I,
                 edges=_AI, edge_shifts=_AD, invert=_B, duty_cycle=_D, propagated=_B),
    "rc_nodes": _s(net_id=_S, node=_S, gnd_cap=_D, pin_id=_S),
    "rc_res": _s(net_id=_S, n1=_S, n2=_S, ohm=_D),
    "rc_ccap": _s(net_id=_S, n1=_S, n2_other=_S, farad=_D),
    "annot": _s(kind=_S, inst=_S, from_pin=_S, to_pin=_S, rf=_S, min=_D, typ=_D, max=_D, cond=_S),
}
