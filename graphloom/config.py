"""Options of a run: keyword arguments with the command line's defaults, and which of them a run records."""

from __future__ import annotations

import argparse
import logging
from dataclasses import asdict, dataclass, fields

#: Fixed names: the configuration keys that a run records.
RECORDED = (
    "model_latent_dim", "model_n_gnn_layers", "model_n_heads", "model_dropout", "loss_lambda_forecast", "loss_lambda_exist", "loss_lambda_comps",
    "loss_lambda_zone", "forecast_decay_factor", "forecast_max_depth", "pressure_singularity_threshold", "collapse_threshold", "phantom_max_count",
    "phantom_gap_threshold",
)

#: Our values for these keys.
DEFAULTS = dict(zip(RECORDED, (64, 2, 4, 0.1, 1.0, 1.0, 1.0, 1.0, 0.8, 4, 5.0, 0.5, 100, 0.3), strict=True))


@dataclass(frozen=True)
class ModeOptions:
    """What the modes take beside their texts."""

    top_k: int = 10
    graph_steps: int = 10
    n_paths: int = 20
    depth: int = 4
    threshold: float = 72.5
    no_neural: bool = False
    output_json: str | None = None
    ckpt: str | None = None
    save_dir: str = "./checkpoints"
    device: str = "cpu"


@dataclass(frozen=True)
class TrainOptions:
    """What training takes; fixed names and defaults of its command line."""

    save_dir: str = "./checkpoints"
    resume: str | None = None
    graph_build_steps: int = 50
    min_nodes_to_train: int = 20
    graph_step_delay: float = 0.0
    train_epochs: int = 100
    batch_size: int = 16
    lr: float = 1e-4
    weight_decay: float = 1e-5
    grad_clip: float = 1.0
    grad_accum: int = 1
    warmup_epochs: int = 5
    graph_interleave_every: int = 0
    graph_interleave_steps: int = 5
    ema_decay: float = 0.9999
    patience: int = 0
    min_delta: float = 1e-5
    save_every: int = 5
    keep_last: int = 3
    num_workers: int = 4
    seed: int = 42


def add_options(parser: argparse.ArgumentParser, options: type) -> None:
    """An argument for each field: flags for booleans, values of the default's type for others."""
    for field in fields(options):
        if isinstance(field.default, bool):
            parser.add_argument(f"--{field.name}", action="store_true")
        else:
            kind = str if field.default is None else type(field.default)
            parser.add_argument(f"--{field.name}", type=kind, default=field.default)


def taken(options: type, args: argparse.Namespace):
    return options(**{f.name: getattr(args, f.name) for f in fields(options)})


def record(options: ModeOptions | TrainOptions, config: dict | None = None) -> dict[str, dict]:
    """``cli_args`` with all options, ``oracle_config`` with the recorded keys of ``config`` only (fixed names of the two parts)."""
    known = DEFAULTS if config is None else config
    return {"cli_args": asdict(options), "oracle_config": {k: known[k] for k in RECORDED if k in known}}


def loggers(level: int = logging.INFO) -> tuple[logging.Logger, logging.Logger]:
    """The engine's and the training's loggers, with one handler to standard error if the program has set none."""
    if not logging.getLogger().handlers:
        logging.basicConfig(level=level, format="%(asctime)s  %(levelname)-8s %(name)s  %(message)s")
    return logging.getLogger("graphloom"), logging.getLogger("graphloom.training")
