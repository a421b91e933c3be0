"""Execution specifications of instances: a lookup of (repository, version) in tables of installs and test commands, and rules on top.

The tables are inputs: installs(repo, version, python, packages, install, pip_packages, pre_install, eval_commands,
no_use_env) and frameworks(repo, version, command), a row a pair.  A pair that one of them lacks is not known to
it; what would need it is null then, and the other half of the specification stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.rules import OLD_MATPLOTLIB, first_match
from ..functions.text import environment_name
from ..sources.tables import small_side

# Parts of the commands.
ARM = ("aarch64", "arm64")
PLATFORMS = {"x86_64": "linux/x86_64", "arm64": "linux/arm64/v8"}
HEREDOC = "EOF_59812759871"
REQUIREMENTS_PATH = "$HOME/requirements.txt"
TRACE = "python3 /root/trace.py --count -C coverage.cover --include-pattern '/testbed/"
QUIET_WARNINGS = "PYTHONWARNINGS='ignore::UserWarning,ignore::SyntaxWarning'"
ESCAPED = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])"
OLD_SETUPTOOLS = "python -m pip install --force-reinstall 'setuptools==75.1.0'"
OLD_NUMPY = "python -m pip install --force-reinstall 'numpy==1.23.5' 'cython<3'"
LOCALE = "sed -i '/en_US.UTF-8/s/^# //g' /etc/locale.gen && locale-gen"
GUARDED_LOCALE = (
    "(test ! -f /etc/locale.gen || (sed -i '/en_US.UTF-8/s/^# //g' /etc/locale.gen && "
    "(command -v locale-gen >/dev/null 2>&1 && locale-gen || true)))"
)


def empty_texts() -> Column:
    return F.array().cast("array<string>")


def architecture(instance: Column, machine: str, x86_only: tuple[str, ...] = ()) -> Column:
    """x86_64, or arm64 on such a machine for instances that are not named as needing x86."""
    return F.when(instance.isin(*x86_only), "x86_64").otherwise("arm64") if machine in ARM else F.lit("x86_64")


def platform(arch: Column) -> Column:
    """The platform of an architecture; another than the two is an error."""
    wrong = F.raise_error(F.concat(F.lit("Invalid architecture: "), arch)).cast("string")
    return first_match([(arch == a, p) for a, p in PLATFORMS.items()], wrong)


def escaped(text: Column) -> Column:
    """A text as a regular expression that matches just it."""
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def quoted(word: Column) -> Column:
    """A word as the shell reads it back."""
    safe = F.regexp_like(word, F.lit(r"^[A-Za-z0-9_@%+=:,./\-]+$"))
    return F.when(word == "", "''").when(safe, word).otherwise(F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def framework_command(command: Column, directives: Column, traced: Column, covered: Column) -> Column:
    """The test command with its directives; if traced, under a tracer that looks at the covered files only.

    A command that begins by setting warnings loses all characters of that setting at its end, as users of such
    records know it.
    """
    plain = F.array_join(F.concat(F.array(command), F.coalesce(directives, empty_texts())), " ")
    files = F.array_join(F.transform(F.coalesce(covered, empty_texts()), escaped), "|")
    tracer = F.concat(F.lit(TRACE + "("), files, F.lit(")'"))
    clean = F.replace(plain, F.lit("--tb=no"), F.lit(""))
    bare = F.regexp_replace(clean, r"^\s+|\s+$", "")
    signs = "[PYTHONWARIGSignore:UstaxyrW,'=]"
    stripped = F.regexp_replace(F.regexp_replace(bare, f"^{signs}+|{signs}+$", ""), r"^\s+|\s+$", "")
    module = r"python(3?) -m"
    at = F.regexp_instr(clean, F.lit(module))
    length = F.length(F.regexp_substr(clean, F.lit(module)))
    replaced = F.concat(F.substring(clean, F.lit(1), at - 1), tracer, F.lit(" -m"), F.substring(clean, at + length, F.length(clean)))
    with_trace = first_match(
        [
            (at > 0, replaced),
            (F.regexp_like(bare, F.lit("^(pytest|unittest|tox)")), F.concat(tracer, F.lit(" -m "), clean)),
            (F.startswith(bare, F.lit(QUIET_WARNINGS)), F.concat(F.lit(QUIET_WARNINGS + " "), tracer, F.lit(" "), stripped)),
        ],
        F.concat(tracer, F.lit(" "), clean),
    )
    return F.when(F.coalesce(traced, F.lit(False)), with_trace).otherwise(plain)


def document(name: str, text: Column) -> Column:
    """A shell command that writes a text into a file."""
    return F.concat(F.lit(f"cat <<'{HEREDOC}' > {name}\n"), text, F.lit(f"\n{HEREDOC}"))


def install_commands(env: Column, install: Column, requirements: Column, environment_yml: Column) -> Column:
    """Commands that make an environment: from a requirements file, from an environment file, or from listed packages."""
    packages = F.coalesce(install["packages"], F.lit(""))
    python = F.concat(F.lit(" python="), install["python"])
    create = lambda extra, rest: F.concat(F.lit(f"conda create {extra}-n "), env, python, rest)
    by_requirements = F.array(
        create("", F.lit(" -y")),
        document(REQUIREMENTS_PATH, requirements),
        F.concat(F.lit("conda activate "), env, F.lit(f" && python -m pip install -r {REQUIREMENTS_PATH}")),
        F.lit(f"rm {REQUIREMENTS_PATH}"),
    )
    updated = F.array(create("-c conda-forge ", F.lit(" -y")), F.lit("conda env update -f environment.yml"))
    created = F.array(F.lit("conda env create --file environment.yml"), F.concat(F.lit("conda activate "), env, F.lit(" && conda install python="), install["python"], F.lit(" -y")))
    steps = F.when(F.coalesce(install["no_use_env"], F.lit(False)), updated).otherwise(created)
    by_file = F.concat(F.array(document("environment.yml", environment_yml)), steps, F.array(F.lit("rm environment.yml")))
    listed = F.array(create("", F.concat(F.lit(" "), packages, F.lit(" -y"))))
    return F.when(packages == "requirements.txt", by_requirements).when(packages == "environment.yml", by_file).otherwise(listed)


def named_environment(text: Column, env: Column) -> Column:
    """An environment file whose lines that name it bear the given name."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.startswith(x, F.lit("name:")), F.concat(F.lit("name: "), env)).otherwise(x)), "\n")


def environment_script(env: Column, commands: Column, pip_packages: Column) -> Column:
    """The script that sets up an environment."""
    pip = F.when(pip_packages.isNotNull(), F.array(F.concat(F.lit("python -m pip install "), F.array_join(pip_packages, " ")))).otherwise(empty_texts())
    steps = F.concat(F.array(F.lit("source ~/miniconda3/bin/activate")), commands, F.array(F.concat(F.lit("conda activate "), env)), pip)
    return F.concat(F.array_join(F.concat(F.array(F.lit("#!/bin/bash"), F.lit("set -euxo pipefail")), steps), "\n"), F.lit("\n"))


def prepare_command(repo: Column, version: Column, install: Column, build_requirements: Column) -> Column:
    """The command that prepares a checkout: what comes before the install, the install itself, and what follows.

    build_requirements: those of the checkout's build system, which an install without isolation needs beforehand.
    """
    own = F.coalesce(install["install"], F.lit(""))
    some = lambda condition, command: F.when(condition, F.array(command)).otherwise(empty_texts())
    needed = F.contains(own, F.lit("--no-build-isolation")) & (F.size(F.coalesce(build_requirements, empty_texts())) > 0)
    steps = F.concat(
        F.coalesce(install["pre_install"], empty_texts()),
        some((repo == "matplotlib/matplotlib") & version.isin(*OLD_MATPLOTLIB), F.lit(OLD_SETUPTOOLS)),
        some((repo == "astropy/astropy") & F.startswith(version, F.lit("1.3")), F.lit(OLD_NUMPY)),
        some(needed, F.concat(F.lit("python -m pip install "), F.array_join(F.transform(build_requirements, quoted), " "))),
        some(own != "", own),
        F.coalesce(install["eval_commands"], empty_texts()),
    )
    command = F.replace(F.array_join(steps, " && "), F.lit("--no-use-pep517 "), F.lit(""))
    return F.replace(command, F.lit(LOCALE), F.lit(GUARDED_LOCALE))


INSTALL_FIELDS = ("python", "packages", "install", "pip_packages", "pre_install", "eval_commands", "no_use_env")


def exec_specs(instances: DataFrame, installs: DataFrame, frameworks: DataFrame, texts: DataFrame, machine: str = "x86_64", x86_only: tuple[str, ...] = ()) -> DataFrame:
    """The specification of each of instances(instance_id, repo, version, base_commit, environment_setup_commit, test_patch, directives, traced, build_requirements).

    texts(repo, commit, requirements, environment_yml) has the cleaned files of a repository at a commit.  The tables
    are broadcast if they are small, else joined by shuffles.
    """
    commit = F.coalesce("environment_setup_commit", "base_commit")
    rows = instances.withColumn("environment_setup_commit", commit)
    install = installs.select("repo", "version", F.struct(*INSTALL_FIELDS).alias("install"))
    test = frameworks.select("repo", "version", F.col("command").alias("_command"))
    files = texts.select("repo", F.col("commit").alias("environment_setup_commit"), "requirements", "environment_yml")
    joined = rows.join(small_side(install), ["repo", "version"], "left").join(small_side(test), ["repo", "version"], "left").join(files, ["repo", "environment_setup_commit"], "left")
    env = environment_name(F.col("repo"), F.col("version"))
    spec = joined.withColumns({"env_name": env, "arch": architecture(F.col("instance_id"), machine, x86_only), "coverage_files": F.array_sort(paths.changed_files(F.coalesce("test_patch", F.lit(""))))})
    known = F.col("install").isNotNull()
    made = install_commands(F.col("env_name"), F.col("install"), F.col("requirements"), named_environment(F.col("environment_yml"), F.col("env_name")))
    spec = spec.withColumn("req_install_commands", F.when(known, made))
    return spec.select(
        "instance_id", "repo", "version", "base_commit", "environment_setup_commit", "env_name",
        F.concat(F.lit("/"), F.col("env_name")).alias("repo_directory"),
        "arch",
        platform(F.col("arch")).alias("platform"),
        "coverage_files",
        known.alias("known_install"),
        F.col("_command").isNotNull().alias("known_tests"),
        "install",
        F.when(F.col("_command").isNotNull(), framework_command(F.col("_command"), F.col("directives"), F.col("traced"), F.col("coverage_files"))).alias("test_command"),
        "req_install_commands",
        F.when(known, environment_script(F.col("env_name"), F.col("req_install_commands"), F.col("install.pip_packages"))).alias("env_script"),
        F.when(known, prepare_command(F.col("repo"), F.col("version"), F.col("install"), F.col("build_requirements"))).alias("setup_command"),
    )


def dumped(specs: DataFrame, out: str = "spec") -> DataFrame:
    """(instance_id, ``out``): each specification as JSON; its test_cmd is always empty, as readers of the format expect."""
    fields = ["instance_id", "repo", "version", "base_commit", "environment_setup_commit", "env_name"]
    return specs.select("instance_id", F.to_json(F.struct(*[F.coalesce(f, F.lit("")).alias(f) for f in fields], "install", F.lit("").alias("test_cmd"))).alias(out))
