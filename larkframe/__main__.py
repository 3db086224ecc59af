import sys

from larkframe.cli import main

sys.exit(main())
