"""Where intermediate tables go: the folder every executor of the cluster can reach."""

import tempfile
import uuid


def shared_folder(spark):
    """The folder named in ``spark.checkpoint.dir``; a local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="prefspark-")


def ensure_checkpoint_dir(spark):
    """Make ``DataFrame.checkpoint`` usable without overriding what the cluster has set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def new_table_path(spark, name):
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark, path):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def path_exists(spark, path):
    """Whether a file or folder exists, in whatever file system the path names."""
    files, found = _file_system(spark, path)
    return files.exists(found)


def names_in(spark, path):
    """The names of the files and folders in a folder; none where there is no folder."""
    files, found = _file_system(spark, path)
    if not files.exists(found):
        return []
    return [status.getPath().getName() for status in files.listStatus(found)]


def remove_path(spark, path):
    """Remove a file or a folder with all it holds."""
    files, found = _file_system(spark, path)
    files.delete(found, True)


def write_text_once(spark, path, text):
    """Write a small file that readers see whole or not at all; False if there is one already.

    The file is written under another name and then renamed.
    """
    files, found = _file_system(spark, path)
    _, draft = _file_system(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    # Some file systems replace a file when another one is renamed to its name.
    done = not files.exists(found) and files.rename(draft, found)
    if not done:
        files.delete(draft, False)
    return done


def read_text(spark, path):
    """The text of a small file."""
    files, found = _file_system(spark, path)
    stream = files.open(found)
    try:
        size = files.getFileStatus(found).getLen()
        return bytes(stream.readNBytes(int(size))).decode()
    finally:
        stream.close()


# Paths of staged tables by session.
_STAGED = {}


def _session(spark):
    return spark._jsparkSession.hashCode()


def staged(df, name):
    """``df`` as a table in the shared folder: computed once, kept when executors are lost.

    ``drop_staged`` removes what a session has staged.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.setdefault(_session(spark), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark):
    """Remove what this session has staged. Results that still read it can't be used after."""
    for path in _STAGED.pop(_session(spark), []):
        remove_path(spark, path)
