"""Spark-native analytics for simulation outputs and Markov-chain runs."""

from .functions.units import Units, convert_units
from .operators.analyses import list_analyses, plot_analyses, plot_data
from .operators.collection import Collection, ModelCollection, open_models, open_outputs
from .operators.convergence import RhatResult, convergence_step, gelman_rubin, geweke, outlier_chains
from .operators.history import trace_galaxy_history
from .operators.mixing import acceptance_rate, acceptance_rate_trace, autocorrelation_function, autocorrelation_time, effective_sample_size
from .operators.outputs import OutputIndex, OutputMeta
from .operators.parameters import apply_state, emit_parameter_files, read_parameter_file, resolve_parameter_path, write_parameter_file_to
from .operators.run import MCMCRun, open_mcmc
from .operators.star_formation import sfh_collapse_metallicities, sfh_times
from .operators.summaries import MaxResult, MVNFit, PosteriorSamples, ProjectionPursuitResult, corner_plot, maximum_likelihood, maximum_posterior, multivariate_normal_fit, posterior_samples, projection_pursuit
from .session import session
from .sources.chains import Chain, ChainSet, read_chains
from .sources.config import Likelihood, MCMCConfig, ModelParameter, PerturberSpec, PriorSpec, parse_mcmc_config

__version__ = "0.1.0"

#: Public names.
__all__ = [
    "Chain", "ChainSet", "Collection", "Likelihood", "MCMCConfig", "MCMCRun", "MVNFit", "MaxResult", "ModelCollection", "ModelParameter", "OutputIndex", "OutputMeta", "PerturberSpec", "PosteriorSamples",
    "PriorSpec", "ProjectionPursuitResult", "RhatResult", "Units", "acceptance_rate", "acceptance_rate_trace", "apply_state", "autocorrelation_function", "autocorrelation_time", "convergence_step", "convert_units",
    "corner_plot", "effective_sample_size", "emit_parameter_files", "gelman_rubin", "geweke", "list_analyses", "maximum_likelihood", "maximum_posterior", "multivariate_normal_fit", "open_mcmc", "open_models",
    "open_outputs", "outlier_chains", "parse_mcmc_config", "plot_analyses", "plot_data", "posterior_samples", "projection_pursuit", "read_chains", "read_parameter_file", "resolve_parameter_path", "session",
    "sfh_collapse_metallicities", "sfh_times", "trace_galaxy_history", "write_parameter_file_to",
]
